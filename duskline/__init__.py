"""Learn when recurring daily deliveries arrive, and forecast them, on Spark."""
