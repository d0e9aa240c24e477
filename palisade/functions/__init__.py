"""SQL expression builders shared by the operators.

They take and return SQL text. The plans of this library hold thousands of expressions;
stating them as text and handing each projection to Spark in one call keeps plan building
fast, and everything still runs as built-in expressions inside the JVM.
"""
