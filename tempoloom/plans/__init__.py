"""Plans composed of operators: retrieval, context, and the engine around them."""
