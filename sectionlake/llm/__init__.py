"""Operations of a training-data pipeline: fingerprints, near duplicates, sharding, packing, filters, tokens."""
