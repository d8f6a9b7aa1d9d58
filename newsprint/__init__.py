"""Spark jobs that turn news feeds and crawled pages into finite daily editions."""
