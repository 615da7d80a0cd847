"""Plans that answer whole queries over a folder of tables."""
