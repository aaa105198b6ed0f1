"""Reading, conforming and checkpointing tables."""
