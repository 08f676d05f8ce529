"""Plan building blocks: skew-safe joins, ranks and quantiles, time spines, scratch space."""
