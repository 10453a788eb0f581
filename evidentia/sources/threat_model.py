"""Default sources, sinks and guards by language, and the draft of a threat model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Text patterns that the graph's symbols are matched with.
SOURCES = {
    "python": ["request.args", "request.form", "request.json", "request.values"],
    "rust": [
        "axum::extract::Query", "axum::extract::Path", "axum::extract::Json", "axum::extract::Form", "axum::extract::Multipart", "actix_web::web::Query",
        "actix_web::web::Json", "actix_web::web::Form", "std::env::var", "std::io::stdin",
    ],
    "typescript": ["req.query", "req.body", "req.params", "req.headers", "c.req.query", "c.req.json", "request.json"],
    "go": ["req.", "request.", "r.URL.Query", "r.FormValue", "r.PostFormValue", "r.Body", "r.Header", "ctx.UserValue", "os.Getenv"],
    "php": ["$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_SERVER", "$_FILES", "php://input"],
}
SINKS = {
    "python": ["cursor.execute", "subprocess.run", "subprocess.Popen", "os.system", "eval", "pickle.loads"],
    "rust": [
        "std::process::Command::new", "Command::new", "tokio::process::Command::new", "sqlx::query", "rusqlite::Connection::execute", "diesel::sql_query",
        "std::fs::read", "std::fs::write", "std::fs::File::open", "serde_json::from_str", "bincode::deserialize",
    ],
    "typescript": [
        "child_process.exec", "child_process.execSync", "child_process.spawn", "eval", "Function", "innerHTML", "outerHTML", "document.write", "fs.readFile",
        "fs.writeFile",
    ],
    "go": [
        "exec.Command", "exec.CommandContext", "db.Query", "db.Exec", "db.QueryRow", ".Query(", ".Exec(", "sqlx.Query", "gorm.Raw", "pgx.Query", "goqu.L", "os.Open",
        "os.Create", "os.ReadFile", "ioutil.ReadFile", "filepath.Join", "http.Get", "http.Post", "http.NewRequest", "(*http.Client).Do", "grpc.Dial",
        "gob.NewDecoder", "yaml.Unmarshal",
    ],
    "php": [
        "mysqli_query", "mysql_query", "pg_query", "->query", "->exec", "->prepare", "exec", "system", "shell_exec", "passthru", "proc_open", "popen", "eval", "assert",
        "include", "require", "file_get_contents", "fopen", "unserialize",
    ],
}
GUARDS = {
    "": [
        "Authorize", "authorize", "CheckAccess", "CheckPermission", "HasPermission", "MustOrg", "RequireOrg", "WithOrg", "Permits", "ValidateToken", "Authenticate",
    ],
    "python": ["@login_required", "@permission_required", "current_user", "is_authenticated"],
    "rust": ["ensure_authorized", "must_be_admin", "verify_jwt"],
    "go": ["AuthorizeRequest", 'ctx.Value("org_id")', "verifyOrg", "ensureOrgAccess", "WithAuthorized", "WithAuthorization", "WithAuthentication"],
}
SAME = {"javascript": "typescript"}
ROLES = {"source": SOURCES, "sink": SINKS, "guard": GUARDS}


def defaults(spark: SparkSession) -> DataFrame:
    """Dimension table (role, language, pattern, ordinal); the empty language is all."""
    rows = [(role, lang, p, i) for role, table in ROLES.items() for lang, ps in table.items() for i, p in enumerate(ps)]
    rows += [(role, new, p, i) for role, table in ROLES.items() for new, old in SAME.items() for i, p in enumerate(table.get(old, []))]
    return spark.createDataFrame(rows, "role string, language string, pattern string, ordinal int")


def draft(languages: list[str], overrides: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Sources, sinks and guards for detected languages. A list that is given replaces the defaults of its role."""
    overrides, known = overrides or {}, sorted({SAME.get(x, x) for x in languages})
    model = {"languages": sorted(set(languages))}
    for role, table in ROLES.items():
        own = overrides.get(f"{role}s")
        model[f"{role}s"] = list(own) if own else [*table.get("", []), *(p for lang in known for p in table.get(lang, []))]
    for key in ("in_scope_paths", "exclude_paths"):
        model[key] = list(overrides.get(key, []))
    return model
