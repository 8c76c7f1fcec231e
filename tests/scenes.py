"""Scene records made by arithmetic alone: 1,024 nodes, dense or sparse, all different or sixteen of them repeated."""

from lamella.model import Kind, Member, Obj, Scalar, Text, Vec, scalar

INT, FLOAT = scalar("int32"), scalar("float32")
NODE = Obj("Node", (Member("Id", INT), Member("Name", Text()), Member("Active", Scalar(Kind.BOOL, nullable=True)), Member("X", FLOAT), Member("Y", FLOAT), Member("Z", FLOAT), Member("Parent", Scalar(Kind.INT32, nullable=True)), Member("Children", Vec(INT))))
SCENE = Obj("Scene", (Member("Nodes", Vec(NODE)), Member("Name", Text())))


def scene(name: str) -> dict:
    sparse, shared = name.startswith("sparse"), name.endswith("shared")
    nodes = []
    for i in range(1024):
        n = i % 16 if shared else i
        here = lambda step: not sparse or i % step == 0  # noqa: B023, E731
        nodes.append({"Id": n, "Name": f"node-{n}" if here(4) else None, "Active": n % 2 == 0 if here(3) else None, "X": n * 0.125, "Y": n * -0.25, "Z": n * 0.5, "Parent": n - 1 if here(4) else None, "Children": [n + 1, n + 2, n + 3] if here(8) else None})
    return {"Name": name, "Nodes": nodes}
