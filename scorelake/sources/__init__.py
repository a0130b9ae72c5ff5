"""Sources of evaluation cases."""
