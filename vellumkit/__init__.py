"""vellumkit: curate, pack and evaluate vision-language datasets on Spark."""

__version__ = "0.1.0"
