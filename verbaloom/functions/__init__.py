"""Column functions and vocabularies; none of them shuffles or leaves the JVM."""
