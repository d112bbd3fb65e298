"""Readers and writers: delimited tables, layers of GeoPackage files, raster tiles."""
