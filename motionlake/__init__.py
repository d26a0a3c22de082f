"""motionlake: quality, alignment and curation of motion data on Spark."""
