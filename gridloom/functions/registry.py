"""All function registries by name; adding a key adds a function."""

from gridloom.functions.distances import COLUMNS as DISTANCE_COLUMNS
from gridloom.functions.distances import KERNELS as DISTANCE_KERNELS
from gridloom.functions.distances import PAIRWISE as PAIRWISE_KERNELS
from gridloom.functions.neighborhoods import NEIGHBORHOODS
from gridloom.functions.schedules import DECAYS

__all__ = ["DECAYS", "DISTANCE_COLUMNS", "DISTANCE_KERNELS", "NEIGHBORHOODS", "PAIRWISE_KERNELS", "register_sql"]


def register_sql(spark) -> None:
    """Put ``grid_neighbors(x, y, topology, ord)`` into SQL as a table function."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="neuron_id: int, nbr_id: int, ring: int")
    class GridNeighbors:
        def eval(self, x: int, y: int, topology: str, ord: int):
            from gridloom.functions.lattice import neighbor_list

            for a, b, ring, _ in neighbor_list(x, y, topology, ord):
                yield a, b, ring

    spark.udtf.register("grid_neighbors", GridNeighbors)
