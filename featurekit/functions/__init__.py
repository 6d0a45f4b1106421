"""Order statistics, bin edges and ordered running totals shared by the operators."""
