"""The audit model as SQL common table expressions, for checking against another engine."""

from __future__ import annotations

from trailspark.binding.tables import AS_OF, DATE_RANGE, DORMANT_THRESHOLD, PERIOD_MONTHS

IN_RANGE = f"date_jst >= TIMESTAMP '{DATE_RANGE[0]}' AND date_jst < TIMESTAMP '{DATE_RANGE[1]}' + INTERVAL 1 DAY"
OFF_HOURS = "(hour(date_jst) < 9 OR hour(date_jst) >= 18 OR isodow(date_jst) >= {})"
# Second copies of the risk lists, so that the checks do not depend on the first.
CRITICAL = (
    "('repo.destroy','repo.archived','repo.change_visibility','org.remove_member','team.destroy','hook.create',"
    "'hook.destroy','protected_branch.destroy','secret_scanning.disable')"
)
HIGH_RISK = (
    "('org.add_billing_manager','org.promote_member_to_owner','deploy_key.create','integration_installation.create')"
)
PROFILE_RISK = (
    "('repo.destroy','repo.transfer','repo.access','org.remove_member','org.update_member','team.destroy',"
    "'team.remove_member','hook.config_changed','hook.destroy','secret_scanning.disable','protected_branch.destroy',"
    "'protected_branch.policy_override','business.remove_admin')"
)

VIEWS = {
    "ev": """
      SELECT event_id,
        ts - to_days(CAST(30 * CASE WHEN user_id % 4 = 1 THEN k % 12 ELSE k % 6 END AS INTEGER))
           + INTERVAL 9 HOUR AS date_jst,
        CASE event_type
          WHEN 'click' THEN 'git.clone' WHEN 'view' THEN 'git.fetch'
          WHEN 'purchase' THEN CASE k % 20 WHEN 0 THEN 'repo.destroy' WHEN 1 THEN 'protected_branch.destroy'
                               ELSE 'pull_request.create' END
          WHEN 'signup' THEN CASE k % 20 WHEN 0 THEN 'org.promote_member_to_owner' WHEN 1 THEN 'deploy_key.create'
                             ELSE 'org.invite_member' END
          ELSE CASE k % 20 WHEN 0 THEN 'hook.create' ELSE 'git.push' END END AS action,
        CASE WHEN event_type = 'error' AND k = 99 THEN NULL
             WHEN user_id % 10 = 3 THEN 'user-' || user_id || '[bot]' ELSE 'user-' || user_id END AS actor,
        'org-' || (user_id % 3) AS org,
        CASE WHEN k % 4 <> 0 THEN 'repo-' || (k % 40) END AS repo,
        CASE WHEN event_type = 'signup' THEN 'user-' || k END AS "user",
        CASE WHEN k % 6 = 0 THEN 'team-' || (k % 5) END AS team,
        CASE WHEN k % 7 = 0 THEN NULL WHEN user_id % 5 = 0 THEN '10.0.0.' || (k % 4)
             ELSE '10.0.1.' || (user_id % 200) END AS actor_ip,
        CASE WHEN k % 5 = 0 THEN NULL WHEN k % 17 = 1 THEN 'RU' WHEN k % 19 = 1 THEN 'CN' ELSE 'JP' END
          AS country_code,
        user_id % 10 = 3 AS actor_is_bot,
        'logs-' || (user_id % 2) || '/audit-' || (user_id % 7) || '.ndjson' AS _source_path,
        'audit-' || (user_id % 7) || '.ndjson' AS _source_file,
        CAST(user_id % 7 * 1000 + 500 AS BIGINT) AS _source_bytes
      FROM (SELECT *, CAST(props->>'k' AS INTEGER) AS k FROM events)""",
    "mem": """
      SELECT CASE WHEN c_custkey % 10 = 7 THEN 'renamed-' ELSE 'user-' END || c_custkey AS login, c_custkey AS id,
        'User' AS type, c_custkey % 50 = 0 AS site_admin
      FROM customer""",
    "seat": """
      SELECT 'user-' || (o_custkey + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) AS login, o_custkey AS user_id,
        o_orderpriority AS org_name, o_orderdate AS created_at,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days(8200) + INTERVAL 9 HOUR END AS last_activity_at,
        CASE WHEN o_orderstatus <> 'P' THEN 'editor-' || (o_orderkey % 4) END AS last_activity_editor,
        CASE WHEN o_orderkey % 9 = 0 THEN TIMESTAMP '2024-03-01' END AS pending_cancellation_date
      FROM orders""",
    "latest": """
      SELECT * FROM seat QUALIFY row_number() OVER (PARTITION BY login ORDER BY last_activity_at DESC NULLS LAST,
        org_name NULLS LAST, created_at DESC NULLS LAST, last_activity_editor NULLS LAST,
        pending_cancellation_date NULLS LAST, user_id) = 1""",
    "period": f"SELECT * FROM ev WHERE date_jst >= TIMESTAMP '{AS_OF}' - to_days({30 * PERIOD_MONTHS})",
    "former": r"""
      SELECT DISTINCT actor FROM ev WHERE actor IS NOT NULL AND actor NOT LIKE '%[bot]'
        AND actor NOT IN (SELECT login FROM mem)""",
    "activity": """
      SELECT actor AS login, count(*) AS audit_event_count, max(date_jst) AS last_audit_activity,
        count(DISTINCT action) AS unique_actions
      FROM period GROUP BY actor""",
    "summary": f"""
      SELECT *, date_sub('day', last_activity, TIMESTAMP '{AS_OF}') AS days_inactive FROM (
        SELECT m.login, m.id, m.type, coalesce(a.audit_event_count, 0) AS audit_event_count, a.last_audit_activity,
          coalesce(a.unique_actions, 0) AS unique_actions, l.last_activity_at AS copilot_last_activity,
          l.last_activity_editor, l.pending_cancellation_date,
          greatest(a.last_audit_activity, l.last_activity_at) AS last_activity
        FROM mem m LEFT JOIN activity a ON a.login = m.login LEFT JOIN latest l ON l.login = m.login)""",
    "dormant": f"""
      SELECT *, CASE WHEN audit_event_count = 0 THEN '完全休眠'
        WHEN audit_event_count <= {DORMANT_THRESHOLD // 2} THEN '低活動' ELSE '要観察' END AS status
      FROM summary WHERE audit_event_count <= {DORMANT_THRESHOLD}""",
    "trend": f"""
      SELECT CAST(date_trunc('month', date_jst) AS TIMESTAMP) AS month, CAST(count(*) AS BIGINT) AS total_events,
        CAST(count(*) FILTER (WHERE actor IN (SELECT login FROM dormant)) AS BIGINT) AS dormant_events
      FROM period WHERE actor IN (SELECT login FROM mem) GROUP BY 1""",
}


def with_views(body: str) -> str:
    """The statement with every view in front of it."""
    views = ",\n".join(f"{name} AS ({sql})" for name, sql in VIEWS.items())
    return f"WITH {views}\n{body.strip()}"
