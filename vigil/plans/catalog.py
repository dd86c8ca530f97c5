"""All queries: importing the modules registers them."""

from vigil.plans import embeddings, episodes, evaluation, graph, knowledge, mining, sequence, signal, streams, telemetry  # noqa: F401
from vigil.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES  # noqa: F401
