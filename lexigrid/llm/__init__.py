"""Operations of a training-data pipeline, each by its own method."""
