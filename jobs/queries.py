"""The registered calls of the jobs, each of two runs into one folder, and what SQL makes of their output."""

from __future__ import annotations

from jobs import goal_log, graph_dataset
from spindrift.queries import views as v


def queries():
    return {"job1_graph_dataset": graph_dataset.job1_graph_dataset, "job2_goal_log": goal_log.job2_goal_log}


def oracle_sql():
    return {
        "job1_graph_dataset": v.with_("edges") + """
            SELECT source_index, target_index, synapse_count, synapse_count * sign AS signed_count,
              synapse_count / sum(synapse_count) OVER (PARTITION BY target_index) AS input_share, target_index // 4096 AS target_block
            FROM edges JOIN neurons ON source_index = neuron_index""",
        "job2_goal_log": r"""
            WITH t AS (SELECT conv_id AS session, turn AS step, role AS author, nullif(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')), '') AS goal FROM conversations),
            f AS (SELECT * FROM t WHERE session IS NOT NULL AND step IS NOT NULL AND author IN ('user', 'system', 'assistant') AND goal IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY session, step ORDER BY author, goal) = 1)
            SELECT session, step, goal, sha256(goal) AS goal_id, length(goal) AS chars, length(string_split(goal, ' ')) AS words, 0::BIGINT AS batch, author FROM f""",
    }
