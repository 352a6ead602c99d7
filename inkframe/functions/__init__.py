"""Column functions: literals, detection, and nested documents."""
