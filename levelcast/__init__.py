"""levelcast: a PySpark-native engine for uncertain time series and scenario ensembles."""
