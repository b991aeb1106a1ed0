"""DataFrame -> DataFrame operators of the surveillance analysis."""
