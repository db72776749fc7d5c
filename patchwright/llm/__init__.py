"""Training-data operators: one module per operator, `entry_points` lists their queries."""
