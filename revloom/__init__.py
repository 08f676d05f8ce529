"""Change-history analytics as lazy Spark DataFrame transforms, for many repositories at once."""

REPO = "repo"
