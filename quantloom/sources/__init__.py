"""Where tables come from: generated fixtures, the benchmark-table adapter, partitioned storage, providers."""
