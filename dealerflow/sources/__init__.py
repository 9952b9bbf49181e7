"""Where tables come from: landed extracts, partitioned tables, test tables."""
