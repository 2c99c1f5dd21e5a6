"""Part of auditspark."""
