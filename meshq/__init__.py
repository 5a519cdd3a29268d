"""meshq: nearest-neighbour, box and sensor-record queries as Spark DataFrame plans."""
