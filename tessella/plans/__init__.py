"""Order primitives, the expression language, and the catalogue of registered queries."""
