"""Refresh jobs on Structured Streaming."""
