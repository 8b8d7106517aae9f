"""Part of mailgrain."""
