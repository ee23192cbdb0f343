"""helixframe: DNA-storage encoding and its analytics as Spark DataFrame operators."""
