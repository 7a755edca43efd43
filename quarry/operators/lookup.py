"""Lookups of terms by a remote client, with bounded concurrency, back-off and a status of their own.

A client comes in as a callable that makes one on a worker: it is called with a query
and a time limit and gives the decoded answer, or raises :class:`LookupFailure`,
TimeoutError, OSError or ValueError. Nothing here opens a connection itself.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.memo import Memo
from quarry.scale import checkpoint, look_up

#: Answers of a server after which a call is tried again; tries; seconds of a call and of the first wait, which doubles.
RETRIED = (429, 500, 502, 503)
TRIES, TIMEOUT, FIRST_WAIT = 3, 30.0, 5.0

FOUND, ABSENT, THROTTLED, REFUSED, UNREACHABLE, UNREADABLE, LATE = "found", "absent", "throttled", "refused", "unreachable", "unreadable", "late"


class LookupFailure(Exception):
    """A server's answer that isn't a success; ``code`` is its number."""

    def __init__(self, code: int):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class LookupConfig:
    """``concurrent`` calls at once a task, ``deadline`` seconds for a query with all its tries and waits."""

    tries: int = TRIES
    timeout: float = TIMEOUT
    first_wait: float = FIRST_WAIT
    deadline: float = 120.0
    concurrent: int = 4
    tasks: int = 8


#: Gives the decoded answer to a query within some seconds.
Client = Callable[[str, float], object]


def has_numbered_concept(answer: object) -> bool:
    """Whether an answer lists a concept whose address ends in a number."""
    listed = answer.get("collection") if isinstance(answer, dict) else None
    return any(str(x.get("@id", "")).rsplit("/", 1)[-1].isdigit() for x in listed or [] if isinstance(x, dict))


def look_up_once(client: Client, query: str, config: LookupConfig, accepts: Callable = has_numbered_concept, sleep: Callable = time.sleep, clock: Callable = time.monotonic) -> tuple[str, int]:
    """(status, tries) of one query.

    Throttling, failures of the server or the connection and answers that can't be read
    are tried again after a wait that doubles, unless that would pass the deadline.
    """
    end = clock() + config.deadline
    status = LATE
    for attempt in range(config.tries):
        left = end - clock()
        if left <= 0:
            return LATE, attempt
        try:
            return (FOUND if accepts(client(query, min(config.timeout, left))) else ABSENT), attempt + 1
        except LookupFailure as e:
            status = THROTTLED if e.code == 429 else UNREACHABLE if e.code in RETRIED else REFUSED
            if status == REFUSED:
                return status, attempt + 1
        except ValueError:
            status = UNREADABLE
        except (TimeoutError, OSError):
            status = UNREACHABLE
        wait = config.first_wait * 2**attempt
        if attempt + 1 < config.tries:
            if clock() + wait >= end:
                return LATE, attempt + 1
            sleep(wait)
    return status, config.tries


def statuses(queries: DataFrame, make_client: Callable[[], Client], config: LookupConfig = LookupConfig(), accepts: Callable = has_numbered_concept) -> DataFrame:
    """(key, lookup_status, tries) of each row of ``queries`` (key): one call a row and try, at most ``tasks`` x ``concurrent`` at once."""

    def run(batches):
        import pyarrow as pa

        client = make_client()
        with ThreadPoolExecutor(config.concurrent) as pool:
            for batch in batches:
                keys = batch.column("key").to_pylist()
                found = list(pool.map(lambda q: look_up_once(client, q, config, accepts), keys))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([s for s, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())], ["key", "lookup_status", "tries"])

    return queries.select("key").repartition(config.tasks, "key").mapInArrow(run, "key string, lookup_status string, tries int")


def lookup(df: DataFrame, query: str, make_client: Callable[[], Client], memo: Memo, config: LookupConfig = LookupConfig(), accepts: Callable = has_numbered_concept) -> DataFrame:
    """``df`` with ``found`` (1 or 0) and ``lookup_status`` of its ``query`` column.

    Each different query is asked once, however many rows have it, and its answer is
    stored at once, so that a task or a run that is repeated asks for the rest only. What
    failed isn't stored: it is found = 0 with the status of its failure, and is asked again
    next time. A null or blank query isn't asked and is absent.
    """
    keyed = df.withColumn("_key", F.when(F.trim(query) != "", F.col(query)))
    asked = keyed.select(F.col("_key").alias("key")).distinct()
    failures = []

    def ask(part: DataFrame) -> DataFrame:
        done = checkpoint(statuses(part, make_client, config, accepts))  # calls are made here, once
        answered = F.col("lookup_status").isin(FOUND, ABSENT)
        failures.append(done.filter(~answered).select("key", F.col("lookup_status").alias("failure")))
        return done.filter(answered).select("key", F.col("lookup_status").alias("answer"))

    known = memo.answers(asked, ask).filter("key IS NOT NULL")
    if failures:
        known = known.join(functools.reduce(DataFrame.union, failures), "key", "left").withColumn("answer", F.coalesce("answer", "failure"))
    known = checkpoint(known.select(F.col("key").alias("_key"), F.col("answer").alias("lookup_status")))
    out = look_up(keyed.drop("lookup_status", "found"), known, "_key")
    status = F.coalesce("lookup_status", F.lit(ABSENT))
    return out.withColumns({"lookup_status": status, "found": (status == FOUND).cast("int")}).drop("_key")
