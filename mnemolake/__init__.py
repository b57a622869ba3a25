"""An agent-memory analytics engine on Spark."""
