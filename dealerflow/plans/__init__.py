"""Reports: compositions of the operators."""
