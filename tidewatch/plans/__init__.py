"""Business rules: the rule table, conditions as columns, matching, actions."""
