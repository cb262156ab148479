"""Fields x wanted variables: cleaning, fetch plan, routing and requests."""
