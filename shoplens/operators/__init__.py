"""DataFrame -> DataFrame operators over all users, carts or queries at once."""
