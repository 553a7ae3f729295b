"""Message model and the queries registered for the driver."""
