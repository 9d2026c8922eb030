"""HTML cleaning: a block model of postings, and the Arrow UDF around it."""
