"""spotlattice: DataFrame operators for spatial-domain benchmarking on Spark."""
