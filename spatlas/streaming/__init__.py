"""An extension: daily rasters that arrive as files."""
