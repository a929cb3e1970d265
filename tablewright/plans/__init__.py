"""Query plans as data: plan documents to node tables and text, and edge tables of plan graphs."""
