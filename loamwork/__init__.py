"""loamwork: Spark DataFrame operators for preparing, checking and delivering tables."""
