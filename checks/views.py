"""Views over the given tables that stand for files, findings, replies and events.

The SQL is portable: Spark runs it to feed the queries, DuckDB runs it inside
the oracle statements.  `@SHA256(x)` stands for each engine's hash function.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {"documents": "doc_id", "events": "event_id", "pages": "page_id", "labels": "doc_id"}

VIEWS = {
    "corpus": """
SELECT doc_id AS file_id,
       concat('repo/', CASE WHEN source = 'src3' THEN 'node_modules' ELSE source END,
              '/d', CAST(doc_id AS STRING),
              CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.JS'
                        WHEN 'es' THEN '.yml' ELSE '.md' END) AS file_path,
       text AS content
FROM documents""",
    "findings": """
SELECT event_id AS ordinal,
       concat('src/u', CAST(user_id AS STRING), '/f', CAST(event_id % 5 AS STRING), '.py') AS file_path,
       CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH'
            WHEN 'signup' THEN 'MEDIUM' WHEN 'click' THEN 'LOW' ELSE 'INFO' END AS severity,
       CASE k % 8 WHEN 0 THEN 'SQL Injection' WHEN 1 THEN 'Command Injection'
            WHEN 2 THEN 'Code Injection (eval/exec)' WHEN 3 THEN 'Weak Cryptographic Hash'
            WHEN 4 THEN 'Insecure YAML Deserialization' WHEN 5 THEN 'Hardcoded API Key'
            WHEN 6 THEN 'Path Traversal' ELSE 'Insecure Data Retrieval' END AS type,
       concat('description ', CAST(k AS STRING)) AS description,
       concat('impact ', event_type) AS impact,
       concat('fix <', CAST(k AS STRING), '> & test') AS fix,
       CASE WHEN k % 40 = 0 THEN NULL ELSE CAST(k % 40 AS BIGINT) END AS line_number,
       CAST(80 + k % 20 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
       CASE WHEN event_id % 2 = 0 THEN 'static' ELSE 'llm' END AS source
FROM (SELECT *, CAST(substring(props, 7, length(props) - 7) AS INT) AS k FROM events) e""",
    "responses": """
SELECT doc_id AS resp_id,
       CASE WHEN doc_id % 13 = 0 THEN 'timeout' ELSE NULL END AS error,
       CASE WHEN doc_id % 13 = 0 THEN NULL
            WHEN doc_id % 7 = 0 THEN concat('ok: No_Vulnerabilities', chr(10))
            ELSE concat('---', chr(10), 'SEVERITY: ',
                 CASE doc_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN ' High ' WHEN 2 THEN 'bogus'
                                 WHEN 3 THEN 'LOW' ELSE 'INFO' END, chr(10),
                 'TYPE: ', CASE doc_id % 3 WHEN 0 THEN 'SQL Injection' WHEN 1 THEN 'Open Redirect'
                                           ELSE 'Weak Crypto' END, chr(10),
                 'LINE: ', CASE doc_id % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN '10-15' WHEN 2 THEN 'Line 12'
                                           WHEN 3 THEN '' WHEN 4 THEN '0' ELSE CAST(doc_id AS STRING) END, chr(10),
                 'DESCRIPTION: ', replace(text, chr(10), ' '), chr(10),
                 'IMPACT: lost data', chr(10), 'FIX: first', chr(10), 'second', chr(10),
                 '---', chr(10), '---', chr(10),
                 'SEVERITY: LOW', chr(10), 'TYPE: Hardcoded Token', chr(10), 'LINE: 3', chr(10),
                 'DESCRIPTION: d', chr(10), 'IMPACT: i', chr(10), 'FIX: f', chr(10),
                 '-----', chr(10), 'SEVERITY: HIGH', chr(10), 'LINE: 9', chr(10), '---') END AS response_text
FROM documents""",
    "scan_cache": """
SELECT text AS content, min(doc_id) AS first_id, count(*) AS copies
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY text""",
    "changed": """
SELECT c.file_path,
       CASE c.file_id % 4 WHEN 0 THEN 'removed' WHEN 1 THEN 'added'
                          WHEN 2 THEN 'modified' ELSE NULL END AS status
FROM corpus c WHERE c.file_id % 5 < 3""",
    # Scans go on after they completed or failed, so results also come late.
    "scan_events": """
SELECT e.*, 'Python' AS language, CASE WHEN findings > 0 THEN 'HIGH' END AS severity,
       CASE type WHEN 'log' THEN 'info' END AS level,
       CASE WHEN type IN ('log', 'error') THEN concat('said "', props, '"') END AS text,
       CASE type WHEN 'error' THEN concat('line 1', chr(10), 'line ', CAST(seq AS STRING)) END AS detail,
       CASE type WHEN 'pr_info' THEN concat('Mend <', CAST(seq AS STRING), '>') END AS title,
       CASE type WHEN 'pr_info' THEN concat('o/r', CAST(seq % 7 AS STRING)) END AS repo,
       CASE type WHEN 'pr_info' THEN seq % 900 END AS pr_num,
       CASE type WHEN 'pr_info' THEN concat('b', CAST(seq % 5 AS STRING)) END AS branch,
       CASE type WHEN 'pr_info' THEN concat('u', CAST(scan_id AS STRING)) END AS author,
       CASE type WHEN 'pr_info' THEN concat('https://example.org/a/', CAST(scan_id AS STRING)) END AS avatar,
       CASE type WHEN 'pr_info' THEN concat('https://example.org/pull/', CAST(seq % 900 AS STRING)) END AS pr_url,
       CASE type WHEN 'pr_info' THEN 9 + seq % 9 WHEN 'complete' THEN seq % 3 END AS total_files,
       CASE type WHEN 'pr_info' THEN seq % 9 END AS scannable_files,
       CASE type WHEN 'pr_info' THEN substring(@SHA256(props), 1, 8) END AS sha,
       CASE type WHEN 'complete' THEN seq % 50 END AS total_findings,
       CASE type WHEN 'complete' THEN seq % 50 - seq % 11 % (1 + seq % 50) END AS n_high,
       CASE type WHEN 'complete' THEN seq % 11 % (1 + seq % 50) END AS n_low
FROM (SELECT user_id AS scan_id, event_id AS seq, props,
       CASE WHEN event_type IN ('view', 'click', 'purchase', 'signup')
            THEN concat('f', CAST(event_id % 5 AS STRING), '.py') END AS file,
       CASE event_type WHEN 'view' THEN 'file_start' WHEN 'click' THEN 'file_done'
            WHEN 'purchase' THEN 'file_done' WHEN 'signup' THEN 'file_skip'
            ELSE CASE event_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'error' WHEN 2 THEN 'pr_info' ELSE 'log' END END AS type,
       CASE WHEN event_type = 'view' THEN event_id % 5 END AS idx,
       CASE WHEN event_type = 'view' THEN 5 END AS total,
       CASE WHEN event_type IN ('click', 'purchase')
            THEN CAST(substring(props, 7, length(props) - 7) AS INT) % 4 END AS findings
FROM events) e""",
    "pr_links": """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url
       ELSE concat(' https://github.com/o', CAST(page_id % 7 AS STRING), '/r', CAST(page_id % 3 AS STRING),
                   '/pull/', CAST(page_id AS STRING), CASE WHEN page_id % 2 = 0 THEN '/files' ELSE '' END) END AS pr_url
FROM pages""",
    # Files of the findings view, with clean files, unreadable files and cache hits.
    "files": """
SELECT file_path, 'Python' AS language, @SHA256(file_path) AS file_hash,
       length(file_path) % 3 = 0 AS from_cache,
       CASE WHEN length(file_path) % 7 = 0 THEN 'cannot read' END AS error
FROM (SELECT file_path FROM findings
      UNION SELECT concat('src/u', CAST(user_id AS STRING), '/clean', CAST(event_id % 2 AS STRING), '.py')
      FROM events) p""",
    # Python sources: each document as a comment block, then a risky or harmless
    # snippet.  `head` is the line on which the snippet starts.
    "py_corpus": """
SELECT doc_id AS file_id, doc_id % 12 AS t,
       length(text) - length(replace(text, chr(10), '')) + 2
         + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS head,
       concat('repo/', source, '/d', CAST(doc_id AS STRING),
              CASE WHEN lang = 'fr' THEN '.js' ELSE '.py' END) AS file_path,
       concat('# ', replace(text, chr(10), concat(chr(10), '# ')), chr(10),
              CASE WHEN doc_id % 4 = 0 THEN concat('DB_PASSWORD = "pw', CAST(doc_id % 9 AS STRING), 'word"', chr(10))
                   ELSE '' END,
              CASE doc_id % 12
                WHEN 0 THEN concat('import os', chr(10), 'os.system(f"echo {name}")', chr(10))
                WHEN 1 THEN concat('import os', chr(10), 'os.popen(command)', chr(10))
                WHEN 2 THEN concat('import subprocess', chr(10), 'subprocess.run(command, shell=True)', chr(10))
                WHEN 3 THEN concat('cur.execute(f"SELECT {name}")', chr(10))
                WHEN 4 THEN concat('cur.execute("SELECT %s" % name)', chr(10))
                WHEN 5 THEN concat('db.cursor().execute("SELECT {}".format(name))', chr(10))
                WHEN 6 THEN concat('digest = hashlib.md5(blob).hexdigest()', chr(10))
                WHEN 7 THEN concat('value = pickle.loads(blob)', chr(10))
                WHEN 8 THEN concat('value = yaml.load(blob, Parser)', chr(10))
                WHEN 9 THEN concat('print(eval(exec(blob)))', chr(10))
                WHEN 10 THEN concat('alias.run(command, shell=True)', chr(10),
                                    'yaml.load(blob, Loader=Safe)', chr(10), 'cur.execute(query)', chr(10))
                ELSE concat('def broken(:', chr(10), 'eval(blob)', chr(10)) END) AS text
FROM documents""",
    # Which calls each snippet holds, in order, and the rule each one trips.
    "snippet_calls": """
SELECT * FROM (VALUES
  (0, 0, 1, 'attribute', 'os', 'system', 'fstring', '', '', 'command_injection'),
  (1, 0, 1, 'attribute', 'os', 'popen', 'other', '', '', 'command_injection'),
  (2, 0, 1, 'attribute', 'subprocess', 'run', 'other', 'shell', 'shell', 'shell_true'),
  (3, 0, 0, 'attribute', 'cur', 'execute', 'fstring', '', '', 'sql_injection'),
  (4, 0, 0, 'attribute', 'cur', 'execute', 'mod', '', '', 'sql_injection'),
  (5, 0, 0, 'attribute', NULL, 'execute', 'format_call', '', '', 'sql_injection'),
  (5, 1, 0, 'attribute', 'db', 'cursor', 'none', '', '', NULL),
  (5, 2, 0, 'attribute', NULL, 'format', 'other', '', '', NULL),
  (6, 0, 0, 'attribute', NULL, 'hexdigest', 'none', '', '', NULL),
  (6, 1, 0, 'attribute', 'hashlib', 'md5', 'other', '', '', 'weak_hash'),
  (7, 0, 0, 'attribute', 'pickle', 'loads', 'other', '', '', 'pickle_loads'),
  (8, 0, 0, 'attribute', 'yaml', 'load', 'other', '', '', 'yaml_load'),
  (9, 0, 0, 'name', NULL, 'print', 'other', '', '', NULL),
  (9, 1, 0, 'name', NULL, 'eval', 'other', '', '', 'code_injection'),
  (9, 2, 0, 'name', NULL, 'exec', 'other', '', '', 'code_injection'),
  (10, 0, 0, 'attribute', 'alias', 'run', 'other', 'shell', 'shell', NULL),
  (10, 1, 1, 'attribute', 'yaml', 'load', 'other', 'Loader', '', NULL),
  (10, 2, 2, 'attribute', 'cur', 'execute', 'other', '', '', NULL)
) AS s(t, call_seq, line_offset, func_kind, base_name, func_name, arg0_kind, kw_names, kw_true, rule)""",
}

NEEDS = {
    "changed": ("corpus",), "files": ("findings",),
}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table that sits in fewer splits than there are cores.

    A single small parquet row group would keep all work on one core; larger
    tables already have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def load_tables(spark: SparkSession, sf_dir: str) -> None:
    for table, key in TABLES.items():
        spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key).createOrReplaceTempView(table)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    load_tables(spark, sf_dir)
    for needed in NEEDS.get(name, ()):
        spark.sql(VIEWS[needed]).createOrReplaceTempView(needed)
    return spark.sql(re.sub(r"@SHA256\((\w+)\)", r"sha2(\1, 256)", VIEWS[name]))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "corpus").withColumnRenamed("content", "text")


def py_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "py_corpus")


def duck_views() -> str:
    """All views as a WITH list for DuckDB."""
    parts = [f"{name} AS ({sql.replace('@SHA256', 'sha256')})" for name, sql in VIEWS.items()]
    return "WITH " + ",\n".join(parts)
