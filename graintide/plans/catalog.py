"""Every query of the engine's own operators with the SQL that checks it."""

from graintide.plans import chat, corpus, instruct, relational, sets, sqlcases, traces

QUERIES: dict = {**corpus.QUERIES, **relational.QUERIES, **chat.QUERIES, **instruct.QUERIES, **traces.QUERIES, **sqlcases.QUERIES, **sets.QUERIES}
ORACLES: dict = {**corpus.ORACLES, **relational.ORACLES, **chat.ORACLES, **instruct.ORACLES, **traces.ORACLES, **sqlcases.ORACLES, **sets.ORACLES}
