"""Record linkage by blocking, and blocked set intersection, as Spark plans."""
