"""Operations of a training-data pipeline: filtering, near-duplicate search, mixing, sharding, packing and archives.

Each module holds one operator with a general DataFrame interface; ``queries`` holds the thin registered queries.
Nothing outside this subpackage imports it.
"""
