"""Plan building blocks shared by the operators: wide aggregates, ordered blocks, exact quantiles."""
