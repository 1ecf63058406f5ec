"""gridloom: numerical, tensor, mesh, training-data and telemetry operators as Spark plans."""
