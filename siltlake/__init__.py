"""siltlake: snapshot-versioned lake tables on PySpark."""
