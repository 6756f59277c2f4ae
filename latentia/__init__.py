"""latentia: corpus preparation, latent-state models and their evaluation on Spark."""
