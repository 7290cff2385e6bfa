from . import index, media, queries, search, views  # noqa: F401
