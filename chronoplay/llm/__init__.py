"""Operations of a large-scale text-corpus pipeline, written as Spark jobs.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
