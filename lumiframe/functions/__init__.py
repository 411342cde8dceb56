"""Part of lumiframe."""
