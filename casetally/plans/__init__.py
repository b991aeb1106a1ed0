"""Compositions: the surveillance results and the stand-in queries on driver tables."""
