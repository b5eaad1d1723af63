"""Training-data operators: thirteen corpus operators, their queries and their oracles.

Nothing outside this folder imports it; ``__spark_entry__`` adds the queries when it is present.
"""
