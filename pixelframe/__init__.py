"""pixelframe: image segmentation as relational dataflow on Spark DataFrames."""

__version__ = "0.1.0"
