"""Sources: observation tables and adapters that present other tables as observations."""
