"""A remote recogniser as a provider: the tasks that hold crops post them, in requests planned over the healthy servers' replicas; a request that fails is halved
until the bad crop stands alone. Off unless it is asked for."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWERED = "frame_id long, word_id int, text string, conf double, seconds double, model_seconds double, error string"
#: Crops of a request at most, unless a batch is given; the batch that servers are first told to work in.
MOST, HINT = 256, 64
Post = Callable[[str, list[bytes], int, float], dict]


class Refused(Exception):
    """The server answered, but not with results: the request is at fault, or too large. Another server would say the same."""


def http_post(url: str, crops: list[bytes], hint: int, timeout: float) -> dict:
    """Posts crops (codec.pack) as files `images` of one form with `batch_size` to url/recognize_batch; the JSON answer. Refused for an answer with an error, OSError
    if there is none."""
    edge = uuid.uuid4().hex.encode()
    part = b'--%s\r\nContent-Disposition: form-data; name="images"; filename="crop_%d.raw"\r\nContent-Type: application/octet-stream\r\n\r\n%s\r\n'
    body = b"".join(part % (edge, i, c) for i, c in enumerate(crops))
    body += b'--%s\r\nContent-Disposition: form-data; name="batch_size"\r\n\r\n%d\r\n--%s--\r\n' % (edge, hint, edge)
    request = urllib.request.Request(f"{url}/recognize_batch", body, {"Content-Type": f"multipart/form-data; boundary={edge.decode()}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise Refused(f"{e.code} {e.reason}") from e
    except ValueError as e:
        raise Refused(str(e)) from e


def healthy(urls: list[str], timeout: float = 5.0) -> dict[str, dict]:
    """The health answers of the servers that give one. RuntimeError if none does."""
    out = {}
    for url in urls:
        try:
            with urllib.request.urlopen(f"{url}/health", timeout=timeout) as answer:
                out[url] = json.load(answer)
        except (OSError, ValueError):
            continue
    if not out:
        raise RuntimeError(f"no recogniser answers at {', '.join(urls)}")
    return out


def shares(n: int, parts: int) -> list[range]:
    """range(n) in up to `parts` runs whose lengths differ by one at most."""
    cuts = [i * n // parts for i in range(parts + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def planned(n: int, servers: dict[str, int], batch: int | None = None, first: int = 0) -> list[tuple[str, range]]:
    """The requests for n crops: an even run for each server, beginning with the first-th, in one request for each of its replicas, more if one would have over
    `batch` crops."""
    names = list(servers)
    names = names[first % len(names) :] + names[: first % len(names)]
    out = []
    for url, run in zip(names, shares(n, len(names))):
        requests = max(1, min(len(run), max(servers[url], -(-len(run) // (batch or MOST)))))
        out += [(url, range(run.start + part.start, run.start + part.stop)) for part in shares(len(run), requests)]
    return out


@dataclass
class Outcome:
    """A crop's answer."""

    text: str = ""
    conf: float = 0.0
    seconds: float = 0.0
    model_seconds: float = 0.0
    error: str | None = None


@dataclass
class Sender:
    """Sends requests to servers; one that does not answer is not asked again by this task."""

    urls: list[str]
    timeout: float
    post: Post
    down: set[str] = field(default_factory=set)

    def _asked(self, url: str, crops: list[bytes], hint: int) -> dict:
        """The answer of url, or of the next server that is up."""
        at, last = self.urls.index(url), "no server is up"
        for k in range(len(self.urls)):
            one = self.urls[(at + k) % len(self.urls)]
            if one in self.down:
                continue
            try:
                return self.post(one, crops, hint, self.timeout)
            except OSError as e:
                self.down.add(one)
                last = f"{one}: {e or type(e).__name__}"
        raise ConnectionError(last)

    def send(self, url: str, crops: list[bytes], hint: int) -> list[Outcome]:
        """An outcome for each crop. A refused request is sent again in two halves, to be worked on in half as large batches, down to single crops: what a crop
        spoils it spoils for itself alone."""
        start = time.time()
        try:
            answer = self._asked(url, crops, hint)
        except ConnectionError as e:
            return [Outcome(error=str(e), seconds=time.time() - start)] * len(crops)
        except Refused as e:
            if len(crops) == 1:
                return [Outcome(error=str(e), seconds=time.time() - start)]
            half, hint = len(crops) // 2, max(1, hint // 2)
            return self.send(url, crops[:half], hint) + self.send(url, crops[half:], hint)
        took, model = time.time() - start, float(answer.get("model_time") or 0)
        results = (list(answer.get("results") or []) + [{}] * len(crops))[: len(crops)]
        return [Outcome(r.get("text") or "", float(r.get("conf") or 0), took, model) for r in results]


def reader(urls: list[str], batch: int | None = None, timeout: float = 60.0, post: Post = http_post, health: Callable[[list[str]], dict[str, dict]] = healthy) -> Callable[[DataFrame], DataFrame]:
    """A function of crops(frame_id, word_id, data): ANSWERED. Health is asked once, when it is called: servers without an answer are left out, and RuntimeError is
    raised if there is none. Each task begins with another server and has as many requests under way as there are replicas.

    A crop that no server takes has text "", conf 0 and an error; all others go on. Crops without data are not sent and have no row. seconds is the time of a
    crop's request, model_seconds what the server says of it."""

    def provider(crops: DataFrame) -> DataFrame:
        servers = {url: max(1, int(found.get("num_replicas") or 1)) for url, found in health(urls).items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, sender = TaskContext.get().partitionId(), Sender(list(servers), timeout, post)
            with ThreadPoolExecutor(sum(servers.values())) as pool:
                for rows in batches:
                    data = rows.column("data").to_pylist()
                    plan = planned(len(data), servers, batch, first)
                    sent = [pool.submit(sender.send, url, [data[i] for i in part], batch or HINT) for url, part in plan]
                    found = [None] * len(data)
                    for (_, part), future in zip(plan, sent):
                        for i, outcome in zip(part, future.result()):
                            found[i] = outcome
                    values = {k: [getattr(o, k) for o in found] for k in ("text", "conf", "seconds", "model_seconds", "error")}
                    kinds = {"text": pa.string(), "error": pa.string()}
                    yield pa.RecordBatch.from_pydict({"frame_id": rows.column("frame_id"), "word_id": rows.column("word_id")} | {k: pa.array(v, kinds.get(k, pa.float64())) for k, v in values.items()})

        return crops.where(F.octet_length("data") > 0).select(F.col("frame_id").cast("long"), F.col("word_id").cast("int"), "data").mapInArrow(run, ANSWERED)

    return provider
