"""Jobs: augment, grid, split, fits, predictions, sites, link budget, lineage."""
