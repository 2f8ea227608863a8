"""plotweld: reconciliation of parcel map layers as PySpark DataFrame programs."""
