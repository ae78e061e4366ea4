"""The registered queries: Spark implementation + equivalent SQL oracle (where SQL can say it).

The queries live in ``panelspark.plans.queries`` (one module per area); importing this module
registers all of them in ``REGISTRY``.
"""

from panelspark.plans.queries import (  # noqa: F401  (import registers the queries)
    evaluation, events, generator, inventory, models, panel as panel_queries, split, text,
)
from panelspark.plans.queries import sources as source_queries  # noqa: F401  (after the queries whose SQL it shares)
from panelspark.plans.queries.common import (  # noqa: F401
    REGISTRY, features, ipanel, panel, predictions, raw_features, split_features, train_test,
)
from panelspark.plans.queries.generator import n_subjects  # noqa: F401
from panelspark.plans.queries.models import boosted_model, joint_model  # noqa: F401
from panelspark.plans.queries.panel import q_participant_features  # noqa: F401
from panelspark.plans.queries.text import q_score_text_batch  # noqa: F401
from panelspark.plans.queries.models import q_boosted_trees_score, q_joint_embedding_score  # noqa: F401
