"""Public-spending analytics as composable DataFrame operators."""
