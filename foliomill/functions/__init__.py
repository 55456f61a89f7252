"""Column builders: no session, no action, no Python on the executors unless in ``udf``."""
