"""Sources and sinks: explicit-type readers, fixed-width files, Parquet hand-offs."""

from casetally.sources.readers import (fixed_width_columns, header_layouts, pack_fixed_width, read_checkpoint,
                                       read_csv_na, read_delimited, read_fixed_width, write_checkpoint,
                                       write_delimited_years, write_result_csv)

__all__ = ["fixed_width_columns", "header_layouts", "pack_fixed_width", "read_checkpoint", "read_csv_na",
           "read_delimited", "read_fixed_width", "write_checkpoint", "write_delimited_years",
           "write_result_csv"]
