"""Operations of a training-data pipeline over text, media and vectors, as Spark jobs."""
