"""tensorloom: semiring tensor contraction expressed as Spark relational plans."""
