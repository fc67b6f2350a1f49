"""Training-data operators: quality, fingerprints, scoring, filtering, packing, archives, joins and mixing."""
