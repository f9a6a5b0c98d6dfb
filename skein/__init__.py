"""skein: persistent homology of Vietoris-Rips filtrations on Spark DataFrames."""

__version__ = "0.1.0"
