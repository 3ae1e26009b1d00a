"""Complete analyses put together from the operators."""
