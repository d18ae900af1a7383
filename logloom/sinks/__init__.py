"""Writers and text renderings of results."""
