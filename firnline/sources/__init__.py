"""Readers and writers of trace tables, rasters, stage outputs and manifests."""
