"""Image-catalog analytics and training-data preparation on Spark."""
