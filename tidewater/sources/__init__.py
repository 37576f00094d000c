"""Where prompts and settings come from."""
