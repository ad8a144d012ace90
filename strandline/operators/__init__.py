"""Table operators: reshaping, joins, ordering, exact quantiles, previous rows."""
