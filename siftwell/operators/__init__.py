"""DataFrame operators: segmentation, indexing, retrieval, evaluation and log rollups."""
