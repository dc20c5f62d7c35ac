"""The three flows end to end, each one lazy plan over all months, charges or sections."""
