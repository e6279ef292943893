"""Portfolio simulation and stock-selection analytics as Spark DataFrame operators."""
