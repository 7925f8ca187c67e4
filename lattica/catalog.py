"""All registered queries and their SQL equivalents."""

from .plans import ORACLE_SQL, QUERIES, decisions, evidence, ingest, io, learning, network, scores, sensor, streams, studies, tuning

__all__ = ["ORACLE_SQL", "QUERIES", "decisions", "evidence", "ingest", "io", "learning", "network", "scores", "sensor", "streams", "studies", "tuning"]
