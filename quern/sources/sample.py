"""A small collection of functions with questions and judgments, for trying an installation out (SRC-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (path::name, source, question it answers).
SAMPLE = [
    ("text/trim.py::strip_margin", "def strip_margin(text, mark='|'):\n    '''Remove the margin mark that starts each line.'''\n    return '\\n'.join(line.split(mark, 1)[-1] for line in text.splitlines())\n", "remove the margin mark in front of every line"),
    ("text/wrap.py::wrap_words", "def wrap_words(words, width):\n    '''Break words into lines no longer than a width.'''\n    lines, line = [], ''\n    for w in words:\n        if line and len(line) + 1 + len(w) > width:\n            lines.append(line)\n            line = w\n        else:\n            line = (line + ' ' + w).strip()\n    return lines + [line]\n", "break words into lines of a given width"),
    ("math/median.py::median", "def median(values):\n    '''Middle value of a sorted list, or the mean of the two middle ones.'''\n    v = sorted(values)\n    n = len(v)\n    return v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2\n", "middle value of an unsorted list of numbers"),
    ("math/factors.py::prime_factors", "def prime_factors(n):\n    '''Prime factors of a number in rising order.'''\n    out, p = [], 2\n    while p * p <= n:\n        while n % p == 0:\n            out.append(p)\n            n //= p\n        p += 1\n    return out + ([n] if n > 1 else [])\n", "prime factors of a number"),
    ("graph/reach.py::reachable", "def reachable(edges, start):\n    '''Nodes that can be reached from a start node, breadth first.'''\n    seen, queue = {start}, [start]\n    while queue:\n        node = queue.pop(0)\n        for other in edges.get(node, ()):\n            if other not in seen:\n                seen.add(other)\n                queue.append(other)\n    return seen\n", "which nodes of a graph can be reached from a node"),
    ("graph/order.py::topological", "def topological(needs):\n    '''Order tasks so that each follows the tasks it needs.'''\n    order, done = [], set()\n    def visit(task):\n        if task not in done:\n            done.add(task)\n            for before in needs.get(task, ()):\n                visit(before)\n            order.append(task)\n    for task in needs:\n        visit(task)\n    return order\n", "order tasks after the tasks they depend on"),
    ("io/tail.py::last_lines", "def last_lines(path, n):\n    '''Read the last lines of a file.'''\n    with open(path) as f:\n        return f.readlines()[-n:]\n", "read the last lines of a file"),
    ("io/retry.py::with_retries", "def with_retries(call, times, wait):\n    '''Call again after a pause when a network request fails.'''\n    for k in range(times):\n        try:\n            return call()\n        except OSError:\n            if k == times - 1:\n                raise\n            sleep(wait * 2 ** k)\n", "try a failing network request again after a pause"),
    ("web/debounce.js::debounce", "function debounce(fn, delay) {\n  // call only after input has been quiet for a while\n  let timer = null;\n  return (...args) => {\n    clearTimeout(timer);\n    timer = setTimeout(() => fn(...args), delay);\n  };\n}\n", "call a handler only after input was quiet for a while"),
    ("web/query.js::parseQuery", "function parseQuery(url) {\n  // parameters of a url as an object\n  const out = {};\n  for (const part of url.split('?')[1].split('&')) {\n    const [key, value] = part.split('=');\n    out[decodeURIComponent(key)] = decodeURIComponent(value);\n  }\n  return out;\n}\n", "parameters of a url as an object"),
    ("data/chunks.py::chunks", "def chunks(items, size):\n    '''Split a list into parts of equal size.'''\n    return [items[k:k + size] for k in range(0, len(items), size)]\n", "split a list into parts of equal size"),
    ("data/merge.py::deep_merge", "def deep_merge(a, b):\n    '''Merge nested dictionaries, the second one wins.'''\n    out = dict(a)\n    for key, value in b.items():\n        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value\n    return out\n", "merge nested dictionaries"),
]


def load_sample(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (id, text), queries (query_id, text) and qrels (query_id, id, rel)."""
    rows = [(f"{name}#1", source, f"q{k:02d}", question) for k, (name, source, question) in enumerate(SAMPLE)]
    corpus = spark.createDataFrame([r[:2] for r in rows], "id string, text string")
    queries = spark.createDataFrame([r[2:] for r in rows], "query_id string, text string")
    return corpus, queries, spark.createDataFrame([(r[2], r[0], 1) for r in rows], "query_id string, id string, rel int")
