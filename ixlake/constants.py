"""Results depend on these, so they are stated once, here."""

# First eight payload bytes of a heartbeat instruction.
HEARTBEAT_DISCRIMINATOR = (156, 17, 23, 219, 237, 102, 17, 27)
HEARTBEAT_MIN_BYTES = 44
HEARTBEAT_NODE_ACCOUNT = 2

HEARTBEAT_PROGRAM = "GtmN6x2aPYq6LkbJTj1qxm5Jn6zGQNWsgG9NFnx1QaEu"

# Program ids the domain extractors listen to.
LENDING_PROGRAMS = (
    "KLend2g3cP87fffoy8q1mQqGKjrxjC8boSyAYavgmjD",
    "So1endDq2YkqhipRh3WViPa8hdiSpxWy6z3Z6tMCpAo",
)
PROOF_PROGRAM = "SySTEM1eSU2p4BGQfQpimFEWWSC1XDFeun3Nqzz3rT7"
ASSET_PROGRAM = "CoREENxT6tW1HoK8ypY1SxRMZTcVPm7R94rH4PZNhX7d"

# Defaults written when a field is missing.
UNKNOWN_SIGNATURE = "unknown"
UNKNOWN_SIGNER = "Unknown"
UNKNOWN_NODE = "Unknown"
NO_SLOT = "unknown"
DEFAULT_REPAID = "0"
STATE_ROOT_STUB = "extracted_root_stub"
PENDING = "PENDING"
VERIFIED = "VERIFIED"
ONLINE = "ONLINE"
OFFLINE = "OFFLINE"
NO_LAUNCH_NAME = "ANONYMOUS_LAUNCH"
NO_SYMBOL = "???"
NO_CREATOR = "UNKNOWN"
NO_VAULT = "..."
LIQUIDATION_WORD = "liquidate"
CURSOR_KEY = "last_processed_slot"

# Envelope columns of generated tables.
IX_ENVELOPE = (
    ("signature", "STRING"),
    ("slot", "BIGINT"),
    ("timestamp", "TIMESTAMP"),
    ("signer", "STRING"),
)
ACC_ENVELOPE = (
    ("solana_address", "STRING"),
    ("slot", "BIGINT"),
    ("last_updated", "TIMESTAMP"),
)

# Interface-description types -> (storage class of the generated table, Spark type).
SCALAR_TYPES = {
    "u8": ("INTEGER", "INT"),
    "i8": ("INTEGER", "INT"),
    "u16": ("INTEGER", "INT"),
    "i16": ("INTEGER", "INT"),
    "u32": ("INTEGER", "BIGINT"),
    "i32": ("INTEGER", "INT"),
    "u64": ("TEXT", "DECIMAL(20,0)"),
    "i64": ("TEXT", "BIGINT"),
    "u128": ("TEXT", "STRING"),
    "i128": ("TEXT", "STRING"),
    "u256": ("TEXT", "STRING"),
    "i256": ("TEXT", "STRING"),
    "f32": ("TEXT", "FLOAT"),
    "f64": ("TEXT", "DOUBLE"),
    "bool": ("INTEGER", "BOOLEAN"),
    "string": ("TEXT", "STRING"),
    "publicKey": ("TEXT", "STRING"),
    "pubkey": ("TEXT", "STRING"),
    "bytes": ("TEXT", "BINARY"),
}

# Workload limits.
TTL_SECONDS = 86_400
TTL_RUN = 1_000_000  # rows of a key between two pauses that one task passes over; longer runs are worked on in parallel
STALE_MINUTES = 10
GAP_SLOTS = 100
LAG_OK_BELOW = 50
LAG_CRITICAL_ABOVE = 500
REPLAY_DEPTH = 20
LOG_PAGE = (100, 1000)          # default, cap
LIQUIDATION_PAGE = (50, 500)    # default, cap
MIN_PROGRAM_ID_LENGTH = 32
